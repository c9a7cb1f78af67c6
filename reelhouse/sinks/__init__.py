"""Writers: snapshots, logs, decision files, review pages, copies and sidecars."""
