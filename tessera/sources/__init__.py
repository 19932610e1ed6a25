"""Readers and stores: corpora from files, versioned files, vectors, run records, checkpoints, local-only guards."""
