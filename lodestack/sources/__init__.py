"""Where rows come from: files, listings of remote systems, and catalogues of standards."""
