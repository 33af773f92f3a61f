"""groundspark: grounded-answer analytics as set-at-a-time Spark plans."""
