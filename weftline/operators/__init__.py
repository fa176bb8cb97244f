"""operators of weftline."""
