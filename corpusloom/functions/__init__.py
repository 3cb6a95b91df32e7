"""Column functions: text, quality, seeded uniforms, token arrays."""
