"""Column functions: text cleaning, guards, hashing, chunking, embedding, parsing of generated scripts."""
