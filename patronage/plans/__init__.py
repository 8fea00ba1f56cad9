"""Plan fragments that several operators share."""
