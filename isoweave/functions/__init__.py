"""Part of the package; see README.md."""
