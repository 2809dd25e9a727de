"""The rules on streams of timeline events."""
