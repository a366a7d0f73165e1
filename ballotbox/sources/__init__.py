"""Image sources, codecs and generators."""
