"""Reading and writing corpora, manifests, index tables and blobs."""
