"""Readers and writers for corpus files, annotations, manifests and logs."""
