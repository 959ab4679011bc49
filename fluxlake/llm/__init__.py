"""Training-data operators over a table of documents, and the queries that apply them. Nothing outside imports this."""
