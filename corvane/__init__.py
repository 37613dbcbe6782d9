"""corvane: Spark-native entity resolution, activity analytics and corpus operators."""
