"""Sources and sinks: taxonomies, JSON lines, example and vector tables, run manifests."""
