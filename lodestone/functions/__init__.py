"""Column functions. All of them are built-in expressions; none runs Python on executors."""
