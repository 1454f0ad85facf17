"""Column functions: names, addresses, times, scores and text measures."""
