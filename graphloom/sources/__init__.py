"""Sources: files, Rust items and calls, advisory corpora."""
