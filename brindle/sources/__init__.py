"""Where rows come from: memory, Parquet, ordered keys, generators and the catalog."""
