"""DataFrame operators: cleaning, features, analytics, lookup, risk and rankings."""
