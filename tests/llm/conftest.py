"""The session of the other tests serves these as well."""
