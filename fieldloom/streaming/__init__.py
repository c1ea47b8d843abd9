"""Graph-field integration over streams of field updates."""
