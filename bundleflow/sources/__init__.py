"""Readers and writers: registry sheet, manifests, blobs, queue messages, versioned tables."""
