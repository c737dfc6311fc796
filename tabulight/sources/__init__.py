"""Reading and writing files, and the cleaning applied while reading."""
