"""Where tables come from: pluggable providers, discovery."""
