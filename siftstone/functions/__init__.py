"""Part of siftstone; see README.md."""
