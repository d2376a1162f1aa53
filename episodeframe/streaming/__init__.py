"""State that advances once an update, as a batch fold and as a stream."""
