"""Table jobs: decoding, chunking, extraction, retrieval, syncing, audits, notes."""
