"""Sources of reads."""
