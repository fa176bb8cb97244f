"""streaming of weftline."""
