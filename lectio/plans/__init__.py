"""The registered queries, and how the given tables become the library's."""
