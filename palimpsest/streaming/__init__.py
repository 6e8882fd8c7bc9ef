"""Online rules as Structured Streaming operators, with their batch twins."""
