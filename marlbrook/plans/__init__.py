"""Plans: the text-query grammar, the query registry and its SQL."""
