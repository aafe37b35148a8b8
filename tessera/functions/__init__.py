"""Part of tessera; see README.md."""
