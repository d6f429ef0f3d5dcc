"""Column functions: text measures, layout, languages, time codes."""
