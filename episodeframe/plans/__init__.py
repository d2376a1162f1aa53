"""Part of the episodeframe engine."""
