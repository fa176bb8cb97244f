"""sources of weftline."""
