"""What the engine leaves: Markdown, reports, stages and service answers."""
