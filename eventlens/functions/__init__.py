"""Column -> Column operators built from Catalyst expressions (text cleaning,
keywords, sections, dates, categories, prompts, answers, ids) and their SQL forms."""
