"""File discovery and decoding to luma planes, and planes from table columns."""
