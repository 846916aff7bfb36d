"""Tables, connectors and the search-item store."""
