"""Column functions on sequences, qualities and alignments."""
