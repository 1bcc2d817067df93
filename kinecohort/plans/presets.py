"""Fixed values of the study: column names, subject ids, cut points, model settings."""

from __future__ import annotations

ID = "id"
TARGET = "sii"
TOTAL = "PCIAT-PCIAT_Total"
AGE, SEX = "Basic_Demos-Age", "Basic_Demos-Sex"

# Cleaning.
ZERO_MEANS_MISSING = ["Physical-BMI", "Physical-Weight", "Physical-Diastolic_BP", "Physical-Systolic_BP"]
DROPPED_IDS = ["83525bbe", "cedf96c5"]
NO_BIA_IDS = ["cedf96c5", "e252dcb6"]
NOT_RELEVANT = [
    "id",
    "Basic_Demos-Age",
    "Basic_Demos-Sex",
    "Physical-Weight",
    "Physical-Height",
    "Physical-HeartRate",
    "Physical-BMI",
]
LABEL_CUTS = [30.5, 49.5, 79.5]
SCORE_CUTS = [0.5, 1.5, 2.5]

# Group statistics.
GROUP_KEYS = ["Basic_Demos-Age", "Basic_Demos-Sex", "neww", "newh"]
GROUP_BINS = {"neww": ("Physical-Weight", 10), "newh": ("Physical-Height", 6)}
NO_GROUP_STATS = ["FGC-Season", "BIA-Season", "BIA-BIA_Activity_Level_num", "BIA-BIA_Frame_num"]

# Derived features.
WAIST = "Physical-Waist_Circumference"
WAIST_MISSING = "missingindicator_Waist_Circumference"
WAIST_SOURCE, WAIST_FACTOR = "Physical-BMI", 1.2
HOURS = "PreInt_EduHx-computerinternet_hoursday"
PRODUCTS = {
    "BMI_Age": ("Physical-BMI", "Basic_Demos-Age"),
    "Internet_Hours_Age": (HOURS, "Basic_Demos-Age"),
    "BMI_Internet_Hours": ("Physical-BMI", HOURS),
    "BFP_BMR": ("BIA-BIA_Fat", "BIA-BIA_BMR"),
    "BFP_DEE": ("BIA-BIA_Fat", "BIA-BIA_DEE"),
}
RATIOS = {
    "BFP_BMI": ("BIA-BIA_Fat", "BIA-BIA_BMI"),
    "FFMI_BFP": ("BIA-BIA_FFMI", "BIA-BIA_Fat"),
    "FMI_BFP": ("BIA-BIA_FMI", "BIA-BIA_Fat"),
    "LST_TBW": ("BIA-BIA_LST", "BIA-BIA_TBW"),
    "BMR_Weight": ("BIA-BIA_BMR", "Physical-Weight"),
    "DEE_Weight": ("BIA-BIA_DEE", "Physical-Weight"),
    "SMM_Height": ("BIA-BIA_SMM", "Physical-Height"),
    "Muscle_to_Fat": ("BIA-BIA_SMM", "BIA-BIA_FMI"),
    "Hydration_Status": ("BIA-BIA_TBW", "Physical-Weight"),
    "ICW_TBW": ("BIA-BIA_ICW", "BIA-BIA_TBW"),
}
SCORE_BIN = {"CGAS-CGAS_Score": ("CGAS-CGAS_Score", 5)}
ALTERNATE_TOTALS = ("PAQ_C-PAQ_C_Total", "PAQ_A-PAQ_A_Total")
ALTERNATE_SEASONS = ("PAQ_C-Season", "PAQ_A-Season")
# Where the merged season goes: the adolescent column is what the study's published
# results use (it is excluded later on); the child column is what its comment intends.
SEASON_INTO = {"published": "PAQ_A-Season", "intended": "PAQ_C-Season"}
SEASONS = [
    "Basic_Demos-Enroll_Season",
    "CGAS-Season",
    "Physical-Season",
    "Fitness_Endurance-Season",
    "FGC-Season",
    "BIA-Season",
    "PAQ_C-Season",
    "SDS-Season",
    "PreInt_EduHx-Season",
]
PCIAT_ITEMS = [f"PCIAT-PCIAT_{i:02d}" for i in range(1, 21)]
EXCLUDED_FEATURES = [
    "PAQ_A-Season",
    "PAQ_C-PAQ_C_Total",
    "PAQ_A-PAQ_A_Total",
    "PCIAT-Season",
    *PCIAT_ITEMS,
    "PCIAT-PCIAT_Total",
    "sii",
    "Fitness_Endurance-Time_Sec",
]

# Feature sets and encoder.
NORMAL, ENCODED = "Normal", "AutoencodedPQ"
AUTOENCODER = {"encoding_dim": 30, "epochs": 100, "learning_rate": 0.001}

# Level-1 models.
AUTOENCODER_ENSEMBLE = {
    "fs": ENCODED,
    "target_col": "sii",
    "init_thresholds": SCORE_CUTS,
    "params": [
        {
            "name": "lgbm",
            "model_class": "LGBMRegressor",
            "params": {
                "n_estimators": 2000, "learning_rate": 0.02, "max_depth": 12, "num_leaves": 1680,
                "min_data_in_leaf": 46, "lambda_l1": 20, "lambda_l2": 75,
                "bagging_fraction": 1, "bagging_freq": 1, "feature_fraction": 1, "random_state": 42,
            },
        },
        {
            "name": "xgb",
            "model_class": "XGBRegressor",
            "params": {
                "n_estimators": 1000, "learning_rate": 0.018, "max_depth": 6, "subsample": 0.89,
                "colsample_bytree": 0.75, "reg_alpha": 34, "reg_lambda": 9, "random_state": 42,
            },
        },
        {
            "name": "catb",
            "model_class": "CatBoostRegressor",
            "params": {
                "learning_rate": 0.015, "depth": 3, "subsample": 0.69, "colsample_bylevel": 0.565,
                "min_data_in_leaf": 88, "iterations": 400, "random_seed": 42,
            },
        },
    ],
}
PLAIN_ENSEMBLE = {
    "fs": NORMAL,
    "target_col": "sii",
    "init_thresholds": SCORE_CUTS,
    "params": [
        {
            "name": "lgbm1",
            "model_class": "LGBMRegressor",
            "params": {
                "n_estimators": 500, "learning_rate": 0.024, "num_leaves": 1440, "max_depth": 15,
                "min_data_in_leaf": 50, "lambda_l1": 25, "lambda_l2": 20,
                "bagging_fraction": 0.9, "bagging_freq": 1, "feature_fraction": 0.7, "random_state": 42,
            },
        },
        {
            "name": "lgbm2",
            "model_class": "LGBMRegressor",
            "params": {
                "n_estimators": 1000, "learning_rate": 0.018, "num_leaves": 360, "max_depth": 17,
                "min_data_in_leaf": 45, "lambda_l1": 30, "lambda_l2": 80,
                "bagging_fraction": 0.9, "bagging_freq": 1, "feature_fraction": 0.9, "random_state": 42,
            },
        },
        {
            "name": "xgb1",
            "model_class": "XGBRegressor",
            "params": {
                "n_estimators": 1000, "learning_rate": 0.067, "max_depth": 9, "subsample": 0.808,
                "colsample_bytree": 0.7, "reg_alpha": 50, "reg_lambda": 59, "random_state": 42,
            },
        },
        {
            "name": "xgb2",
            "model_class": "XGBRegressor",
            "params": {
                "n_estimators": 1000, "learning_rate": 0.0435, "max_depth": 8, "subsample": 0.849,
                "colsample_bytree": 0.759, "reg_alpha": 44, "reg_lambda": 5, "random_state": 42,
            },
        },
    ],
}
NAIVE_ENSEMBLE = {
    "fs": NORMAL,
    "target_col": "sii",
    "init_thresholds": SCORE_CUTS,
    "params": [
        {"name": "xgb1", "model_class": "XGBRegressor", "params": {"random_state": 42}},
        {"name": "lgbm1", "model_class": "LGBMRegressor", "params": {"random_state": 42}},
        {"name": "catb1", "model_class": "CatBoostRegressor", "params": {"random_state": 42}},
    ],
}
MODELS = {
    "autoencoder_ensemble": AUTOENCODER_ENSEMBLE,
    "plain_ensemble": PLAIN_ENSEMBLE,
    "naive_ensemble": NAIVE_ENSEMBLE,
}
