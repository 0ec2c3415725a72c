"""DataFrame jobs: uploads, parsing, chunking, embedding, retrieval, chat, evaluation, governance, lifecycle, limits."""
