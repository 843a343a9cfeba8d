"""File listings, CSV and prediction readers, and sinks."""
