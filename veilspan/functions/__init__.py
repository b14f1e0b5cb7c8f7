"""Part of veilspan."""
