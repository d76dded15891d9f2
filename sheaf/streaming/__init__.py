"""Progress streams: newline-delimited JSON over byte chunks."""
