"""Input views, registered queries and their SQL."""
