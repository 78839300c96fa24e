"""DataFrame operators: latest row per key, status tables, filters, dashboard, search, ingest, report."""
