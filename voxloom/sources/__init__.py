"""Finding, decoding and describing what a job reads: audio files and models."""
