"""Column functions: URLs, HTML clean-up, Markdown, robots rules, fuzzy scores."""
