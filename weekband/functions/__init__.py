"""Column functions: calendar buckets, category recodes and durations."""
