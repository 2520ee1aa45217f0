"""DataFrame operators: extraction, mentions, portfolio aggregates, reports."""
