"""plans of weftline."""
