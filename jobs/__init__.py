"""Jobs: command lines over tables, each a function of a session, and their registration as queries."""
