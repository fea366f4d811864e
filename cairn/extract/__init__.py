"""From source files to rows: symbols, references and flow, one pass per file."""
