"""Part of the quillsieve engine."""
