"""Spark operators for the outputs of vision models: detections, tracks, events, scores."""
