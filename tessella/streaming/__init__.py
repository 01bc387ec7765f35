"""Shadow comparison of two filters, over batches and streams."""
