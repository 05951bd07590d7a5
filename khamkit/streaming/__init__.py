"""The same functions over streams: they keep no state, so a stream only needs a source and a sink."""
