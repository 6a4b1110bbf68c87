"""Reading and writing: snapshots, tables with aliases, panels, ladders, reports."""
