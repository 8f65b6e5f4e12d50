"""Graph operators as DataFrame compositions: edge types, candidates, embeddings, domains, supports."""
