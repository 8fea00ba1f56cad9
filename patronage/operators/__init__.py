"""The analyses, each a lazy DataFrame over the canonical tables."""
