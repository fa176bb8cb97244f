"""functions of weftline."""
