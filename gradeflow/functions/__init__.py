"""Column functions: text, prompts, formats, numbers."""
