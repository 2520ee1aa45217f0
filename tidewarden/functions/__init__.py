"""Column expressions: text repair, extraction, sections, scoring rules."""
