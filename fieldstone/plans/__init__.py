"""Filter documents as predicates, collection models, and the registered queries."""
