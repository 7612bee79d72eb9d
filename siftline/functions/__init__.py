"""Column expressions: text, identity, dates, places, lists, pay, markup."""
