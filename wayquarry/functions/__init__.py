"""Functions on columns: coercion, text, dates, money and geometry."""
