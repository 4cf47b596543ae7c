"""Part of tidewater; see README.md."""
