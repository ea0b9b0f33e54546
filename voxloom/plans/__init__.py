"""Jobs: transcription, diarization and the planning of resources."""
