"""Column expressions: metrics, links, text features, nested documents."""
