"""Web-page analytics on Spark: pages in, nodes, items, links and metadata out."""
