"""Part of the listing analytics library."""
