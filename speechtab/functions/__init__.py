"""User-function surface: NFC, detectors, score models and beam decoding."""
