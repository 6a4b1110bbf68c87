"""The keyed operators over streams: the same results as in batch, month by month or row by row, with bounded state."""
