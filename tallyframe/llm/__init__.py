"""Operators that prepare training data: one module per operator, nothing else imports them."""
