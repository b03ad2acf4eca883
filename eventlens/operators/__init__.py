"""DataFrame -> DataFrame jobs: returns, alignment, news and filing preprocessing,
HTML to text, labelling sheets, batch prediction, scoring and input guards."""
