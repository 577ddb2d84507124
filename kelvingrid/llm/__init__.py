"""Training-data operators on documents, embeddings, pages and conversations."""
