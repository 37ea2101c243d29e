"""Sources: files, payloads and inline dimensions to rows of a known shape."""
