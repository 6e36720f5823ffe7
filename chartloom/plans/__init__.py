"""Whole plans: pages to charts, questions to answers, a cohort to its measures."""
